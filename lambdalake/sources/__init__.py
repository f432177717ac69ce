"""Tables in and out: programs, corpora, trials, predictions, metrics, cached results."""
