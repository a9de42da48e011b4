"""navloom: a Spark-native engine for tiled terrain, navigation meshes and routes."""

__version__ = "0.1.0"
