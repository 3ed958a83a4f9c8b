"""NumPy kernels that run inside one image or tile; arrays are indexed [..., y, x]."""
