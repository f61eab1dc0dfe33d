"""Running a batch job on the files that arrived since the last time."""
