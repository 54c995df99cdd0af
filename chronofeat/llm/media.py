"""Media columns in a deduplicated chunk store.

A payload is a text's UTF-8 bytes, padded with bytes 0; its media form is 8-bit mono PCM (WAVE),
one sample a byte. Payloads are cut where a rolling gear hash of the last bytes has its low bits
clear, so that equal stretches give equal chunks wherever they stand. A chunk is known by its
SHA-256 and kept once, packed with zstandard. A *manifest* lists a payload's chunk digests in
order; equal payloads share a manifest. Joining manifests with the store rebuilds the media,
and every chunk and payload read back is checked against its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Payload unit; least, usual (a power of two) and largest chunk; samples a second; digests that a task remembers.
UNIT, LEAST, USUAL, LARGEST, RATE, SEEN = 64, 2048, 8192, 65_536, 8000, 1_000_000
GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes, payload): padded to the next positive multiple of UNIT; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % UNIT if data else UNIT)


def wave_header(size: int) -> bytes:
    """What precedes `size` samples in a WAVE file of 8-bit mono PCM."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)


def samples_of(media: bytes) -> bytes:
    """The payload of a WAVE file that wave_header() began."""
    size = struct.unpack_from("<I", media, 40)[0]
    if media[:44] != wave_header(size) or len(media) != 44 + size:
        raise ValueError("not a WAVE file of 8-bit mono samples")
    return media[44:]


def cut_points(payload: bytes) -> list[int]:
    """Ends of the payload's chunks."""
    if len(payload) <= LEAST:
        return [len(payload)]
    # each hash covers the last 32 bytes; doubling the stretch gives all of them at once
    rolled = GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        rolled[k:] += rolled[:-k] << np.uint32(k)
    places = np.flatnonzero((rolled >> np.uint32(10)) & np.uint32(USUAL - 1) == 0) + 1
    ends, at = [], 0
    while len(payload) - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        at = min(int(places[k]) if k < len(places) else len(payload), at + LARGEST, len(payload))
        ends.append(at)
    if at < len(payload):
        ends.append(len(payload))
    return ends


def _chunks(payload: bytes) -> Iterator[bytes]:
    at = 0
    for end in cut_points(payload):
        yield payload[at:end]
        at = end


def feature(payload: bytes) -> str:
    """Mean, root mean square, share of mid-line crossings and an 8-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    bins = ",".join(map(str, np.bincount((x + 128) >> 5, minlength=8).tolist()))
    return f"mean={x.mean():.4f};rms={float(np.sqrt((x * x).mean())):.4f};crossings={crossings / max(1, len(x) - 1):.6f};bins={bins}"


def _manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, payloads, lists, names = [], [], [], []
        for t in batch.column("text"):
            n, payload = payload_of(t.as_py())
            digests = [hashlib.sha256(c).digest() for c in _chunks(payload)]
            sizes.append(n)
            payloads.append(len(payload))
            lists.append(digests)
            names.append(hashlib.sha256(b"".join(digests)).digest())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(payloads, pa.int64()), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["key", "n_bytes", "payload_bytes", "manifest", "digests"])


def manifests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, manifest, digests) of each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(_manifests, f"key {kind}, n_bytes long, payload_bytes long, manifest binary, digests array<binary>").withColumnRenamed("key", key)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer, seen = zstandard.ZstdCompressor(level=6), set()
    for batch in batches:
        digests, packs, held = [], [], 0
        for t in batch.column("text"):
            for chunk in _chunks(payload_of(t.as_py())[1]):
                name = hashlib.sha256(chunk).digest()
                if name in seen:  # only spares repeats within a task; the store is deduplicated below
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                digests.append(name)
                packs.append(packer.compress(chunk))
                held += len(packs[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packs, pa.binary())], ["digest", "pack"])
                digests, packs, held = [], [], 0
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packs, pa.binary())], ["digest", "pack"])


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, pack) of each different chunk, once."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_pack, "digest binary, pack binary")
    return rows.repartition("digest").dropDuplicates(["digest"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """(manifest, payload) of rows (manifest, chunks, seq, digest, pack) that come in order."""
    unpacker, held, parts = zstandard.ZstdDecompressor(), None, []
    for batch in batches:
        for name, chunks, seq, digest, pack in zip(*(batch.column(c).to_pylist() for c in ("manifest", "chunks", "seq", "digest", "pack")), strict=True):
            if seq == 0:
                held, parts = name, []
            if pack is None or name != held or seq != len(parts):
                raise ValueError(f"chunk {seq} of manifest {name.hex()} is missing")
            parts.append(unpacker.decompress(pack))
            if hashlib.sha256(parts[-1]).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            if seq + 1 == chunks:
                yield name, b"".join(parts)
                held, parts = None, []


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, payload in _rebuilt(batches):
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([wave_header(len(payload)) + payload], pa.binary())], ["manifest", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["manifest", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    rows: list[tuple] = []
    for name, payload in _rebuilt(batches):
        media = wave_header(len(payload)) + payload
        samples = samples_of(media)
        rows.append((name, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        if len(rows) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _from_store(lists: DataFrame, store: DataFrame, each, schema: str) -> DataFrame:
    """`each` over the chunks of every different manifest, in order; a payload of one chunk needs no gathering."""
    wanted = lists.select("manifest", "digests").dropDuplicates(["manifest"]).select("manifest", F.size("digests").alias("chunks"), F.posexplode("digests").alias("seq", "digest"))
    found = wanted.join(store, "digest", "left").select("manifest", "chunks", "seq", "digest", "pack")
    several = found.where("chunks > 1").repartition("manifest").sortWithinPartitions("manifest", "seq")
    return found.where("chunks = 1").mapInArrow(each, schema).union(several.mapInArrow(each, schema))


def rebuild(lists: DataFrame, store: DataFrame) -> DataFrame:
    """(manifest, media) of each different manifest, every chunk verified; a missing or damaged chunk is an error."""
    return _from_store(lists, store, _media, "manifest binary, media binary")


def media_features(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), of what the store gives back.

    A null or empty text is a payload of UNIT bytes 0. Equal texts, and repeated rows, have equal
    values. A null key keeps its row. An empty table gives an empty result. Other columns are not
    looked at.
    """
    lists = materialize(manifests(docs, key, text), "manifests")
    read = _from_store(lists, chunk_store(docs, text), _features, "manifest binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return lists.select(key, "n_bytes", "payload_bytes", "manifest").join(read, "manifest").drop("manifest")
