"""Plans: operators put together into what a user asks for."""
