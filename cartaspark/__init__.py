"""A Spark-native engine for collections of scanned map sheets and their web-tile pyramids."""
