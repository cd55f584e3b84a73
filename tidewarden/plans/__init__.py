"""End-to-end plans over tables."""
