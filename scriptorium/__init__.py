"""scriptorium: Spark operators for a scientific literature library."""
