"""Conversation capture on Spark."""
