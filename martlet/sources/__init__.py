"""Sources: file readers with declared schemas, row cap, fixture mapping."""
