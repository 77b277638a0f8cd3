"""Reading and writing records, truth, candidate lists and claims."""
