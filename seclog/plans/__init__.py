"""Views and statistics over stored entries and alerts."""
