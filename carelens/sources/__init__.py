"""Readers, stand-in views, sinks and bounded scans."""
