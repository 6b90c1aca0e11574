"""Readers and writers of traces and stores."""
