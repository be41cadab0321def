"""Phishing and scam risk analytics as Spark jobs over tables and streams."""
