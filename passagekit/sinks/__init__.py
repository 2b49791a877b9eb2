"""Writers: stage tables, indexes, vector tables, stores."""
