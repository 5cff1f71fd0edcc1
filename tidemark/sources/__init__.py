"""Where triples and observations come from: event logs, N-Triples text, notifications, live folders."""
