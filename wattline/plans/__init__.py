"""Jobs built from several operators: feature preparation, rounds of training, search, evaluation."""
