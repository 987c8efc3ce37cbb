"""DataFrame-to-DataFrame operators over token, lexicon and result tables."""
