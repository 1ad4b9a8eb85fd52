"""What is still to be loaded: plans of partitions as tables."""
