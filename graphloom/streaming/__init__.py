"""Tables kept up to date by streams of change events."""
