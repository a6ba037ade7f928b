"""Column functions: text, SQL text, prompts, result values and vectors."""
