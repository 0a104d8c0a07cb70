"""Decision- and dialogue-corpus analytics as lazy Spark plans."""
