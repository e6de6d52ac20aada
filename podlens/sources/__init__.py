"""Sources: log lines, catalogs, the journal, rate rules and service annotations."""
