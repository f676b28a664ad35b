"""Where results leave the engine: commands, reports, prompts, model calls."""
