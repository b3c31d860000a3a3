"""Reading and writing frames, predictions, poses and reports."""
