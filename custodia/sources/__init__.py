"""Where relations come from: files, the Spark catalog, and governance logs."""
