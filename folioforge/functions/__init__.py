"""Column functions: text segmentation and sample-array arithmetic."""
