"""The boundary to language models."""
