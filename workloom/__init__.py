"""workloom: Spark jobs over tables and streams of asynchronous work."""
