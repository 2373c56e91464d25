"""The live service as Structured Streaming jobs, built from the batch operators."""
