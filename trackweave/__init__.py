"""trackweave: Spark-native transforms for media-catalogue and job-queue analytics."""
