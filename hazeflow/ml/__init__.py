"""Training, evaluation and explanation of label models."""
