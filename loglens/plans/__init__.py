"""Query catalog: every operator as a named query plus its oracle SQL."""
