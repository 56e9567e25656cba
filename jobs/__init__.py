"""Runnable jobs: each a function that takes a session and plain paths, and a command line around it."""
