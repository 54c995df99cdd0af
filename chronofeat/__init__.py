"""chronofeat: temporal feature datasets on PySpark."""
