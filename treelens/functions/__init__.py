"""Column functions: paths, ignore patterns, text, prompts, answers, markdown."""
