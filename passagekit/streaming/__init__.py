"""Resumable index builds and running stores on Structured Streaming."""
