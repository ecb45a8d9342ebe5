"""Sources and sinks over files Spark reads and writes itself."""
