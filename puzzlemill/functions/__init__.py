"""Column functions: answers, prompts, rewards (native) and exact arithmetic (Arrow)."""
