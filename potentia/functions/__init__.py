from potentia.functions.rand import normal, uniform, uniform_open
from potentia.functions.vec import (
    accept_probability, as_double_array, chebyshev, coord, cosine_distance, distance, dot,
    euclidean, gaussian_kernel, in_box, l2_normalize, manhattan, norm, radial_kernel, scale,
    sq_dist, voltage_to_distance,
)

__all__ = [
    "accept_probability", "as_double_array", "chebyshev", "coord", "cosine_distance", "distance",
    "dot", "euclidean", "gaussian_kernel", "in_box", "l2_normalize", "manhattan", "norm", "normal",
    "radial_kernel", "scale", "sq_dist", "uniform", "uniform_open", "voltage_to_distance",
]
