"""Conversation, speech-text and evaluation analytics as Spark DataFrame operators."""
