"""Named queries over interchangeable layouts, incremental jobs and profiles."""
