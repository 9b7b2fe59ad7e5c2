"""A Spark-native engine for news-style content intelligence."""
