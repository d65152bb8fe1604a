"""Importing this module registers every query."""

from topicscope.plans import q_embed, q_models, q_stats, q_text, q_topics  # noqa: F401
