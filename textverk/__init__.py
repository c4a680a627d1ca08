"""Text-as-data analytics on Spark: term counts, panels, diffusion, qualification, statistics."""

__version__ = "0.1.0"
