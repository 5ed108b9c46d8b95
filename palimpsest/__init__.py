"""palimpsest: revisable, bitemporal memory and training-data operators on PySpark."""
