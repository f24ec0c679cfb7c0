"""DataFrame operators: turns, chunks, index maintenance, recall, compression."""
