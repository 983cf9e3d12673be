"""Column -> Column functions: text cleaning, label extraction, prompts, numbers."""
