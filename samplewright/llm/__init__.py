"""Training-data operators: ten methods over documents, labels, benchmark and conversations."""
