"""Conversation quality analytics on Spark: DataFrame operators over chunks, questions, calls and verdicts."""
