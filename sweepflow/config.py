"""Parameters of segmentation and clustering, with the three sets of defaults that are in use."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class RangeImage:
    """Shape of the endless range image."""

    clockwise: bool = True
    num_columns: int = 1700
    fill_missing_inclinations: bool = True


@dataclass(frozen=True)
class Ground:
    """Ground segmentation within a column."""

    max_slope: float = 0.2
    first_ring_max_dz: float = 0.4
    first_ring_min_dz: float = -0.4
    ground_slope_over: float = -0.1
    ground_distance_under: float = 5.0
    near_ground_max_dz: float = 0.4
    near_ground_max_dr: float = 2.0
    demote_max_dr: float = 0.3
    use_terrain: bool = False
    #: With use_terrain, how far from the point before a flat one may be.
    terrain_max_dr: float = 5.0
    #: Robot's box in its own frame: x, y, z ranges.
    ego_box: tuple[tuple[float, float], tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0), (0.0, 0.0))
    robot_height: float = 0.0
    fog_enabled: bool = False
    fog_intensity_below: int = 2
    fog_distance_below: float = 18.0
    fog_inclination_above: float = -0.06


@dataclass(frozen=True)
class Clustering:
    """Association of points and closing of clusters."""

    max_distance: float = 0.7
    max_steps_in_row: int = 20
    max_steps_in_column: int = 20
    stop_after_association: bool = True
    stop_after_association_min_steps: int = 1
    ignore_chessboard: bool = True
    ignore_big_inclination_gap: bool = True
    last_point_stamps: bool = False
    every_nth_column: int = 1
    #: A cluster gets an id with more points than the first, and is published with more than the second.
    min_points_id: int = 5
    min_points_published: int = 20


@dataclass(frozen=True)
class Config:
    image: RangeImage = field(default_factory=RangeImage)
    ground: Ground = field(default_factory=Ground)
    clustering: Clustering = field(default_factory=Clustering)

    @staticmethod
    def library_defaults() -> Config:
        return Config()

    @staticmethod
    def node_defaults() -> Config:
        """The live node differs in the limits of the first ring."""
        return Config(ground=Ground(first_ring_max_dz=0.5, first_ring_min_dz=-0.2))

    @staticmethod
    def kitti() -> Config:
        """The evaluation runs."""
        base = Config()
        return Config(replace(base.image, num_columns=2200), base.ground, replace(base.clustering, max_distance=0.5, ignore_chessboard=False))
