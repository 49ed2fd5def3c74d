"""Requests, schema validation and plan descriptions. Nothing here touches Spark data."""
