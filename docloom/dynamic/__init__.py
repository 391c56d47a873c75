"""The dynamic lane: documents of any shape, as JSON text, read and evaluated one by one on the executors."""
