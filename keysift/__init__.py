"""Membership filters, one-class models and storage-log analytics for key tables, on Spark."""
