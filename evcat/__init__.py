"""Event-catalogue engine on PySpark."""
