"""Retrieval pipelines and ranking evaluation."""
