"""Column expressions, frame helpers and distributed ranks."""
