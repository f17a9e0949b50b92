"""Conversation-corpus preparation as Spark DataFrame operators."""
