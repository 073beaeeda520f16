"""Traffic-detection analytics as composable ``DataFrame -> DataFrame`` operators."""
