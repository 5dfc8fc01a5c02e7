"""Sky-survey and knowledge-corpus analytics as Spark DataFrame operators."""
