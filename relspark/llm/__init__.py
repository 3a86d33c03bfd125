"""Training-data operators over text, embedding and conversation tables."""
