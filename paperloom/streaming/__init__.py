"""Streaming: folders that are watched for new files."""
