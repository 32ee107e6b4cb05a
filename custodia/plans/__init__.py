"""The modelled pipeline: staging tables, marts, and the run order."""
