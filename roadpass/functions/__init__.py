"""Column helpers shared by the batch, streaming and model jobs."""
