"""Pagewright: web-article extraction and text analytics as Spark DataFrame operators."""

VERSION = "0.1.0"
