"""DataFrame-to-DataFrame operators on events, sessions, scores and reports."""
