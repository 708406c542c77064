"""Sources and sinks for chapters, pages and audio."""
