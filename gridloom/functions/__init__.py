"""Column functions: scalar mathematics, tensors, colours, sample types."""
