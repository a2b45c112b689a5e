"""storyloom: story analytics over feeds of short articles, on PySpark."""
