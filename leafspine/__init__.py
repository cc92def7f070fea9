"""leafspine: document structuring and corpus preparation as Spark DataFrame transformations."""
