"""Row-wise operators on a stream of arriving files."""
