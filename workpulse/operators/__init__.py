"""DataFrame operators over the fact table and its dimensions."""
