"""What a product will cost, and how to run it."""
