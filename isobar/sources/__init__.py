"""Messages of the binary format: layouts, reading, writing, and the Spark source and sink."""
