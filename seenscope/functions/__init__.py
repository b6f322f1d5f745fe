"""Column expressions: prompts, chat records, words, vectors."""
