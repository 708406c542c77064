"""DataFrame operators over tables of chapters, segments, pages and audio."""
