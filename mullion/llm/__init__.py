"""Training-data operators over web pages and documents. Nothing else in the library imports this package."""
