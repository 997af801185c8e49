"""Following the event table as it grows."""
