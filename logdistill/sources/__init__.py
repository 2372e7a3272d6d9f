"""Readers, generators and report writers."""
