"""Reading and writing of readings, client files, trials and checkpoints."""
