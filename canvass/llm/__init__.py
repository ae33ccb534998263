"""Training-data operators: whole-corpus jobs that stand beside the survey engine."""
