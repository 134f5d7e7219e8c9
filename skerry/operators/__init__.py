"""Search, quantisation, graphs and evaluation."""
